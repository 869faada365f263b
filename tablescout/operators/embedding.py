"""Encoders, vector look-up and nearest tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions.scores import cosine, unit, vector_literal

DIMENSIONS = 384

Encoder = Callable[[DataFrame], DataFrame]


def token_weights(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Sparse term counts (table_name, bucket, tf): words hashed into `dimensions` buckets."""
    tokens = texts.select(
        "table_name",
        F.explode(F.regexp_extract_all(F.lower("table_text"), F.lit("[a-z]+"), F.lit(0))).alias("token"),
    )
    bucket = (F.conv(F.right(F.md5("token"), F.lit(4)), 16, 10).cast("int") % dimensions).alias("bucket")
    return tokens.groupBy("table_name", bucket).agg(F.count("*").alias("tf"))


def hashing_encoder(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """E4, default encoder: (table_name, table_text) -> (table_name, table_text, vec), unit vectors."""
    bags = token_weights(texts, dimensions).groupBy("table_name").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "tf"))).alias("bag")
    )
    slots = F.sequence(F.lit(0), F.lit(dimensions - 1))
    dense = F.transform(slots, lambda i: F.coalesce(F.element_at("bag", i), F.lit(0)).cast("double"))
    return (
        texts.join(bags, "table_name", "left")
        .withColumn("bag", F.coalesce("bag", F.create_map().cast("map<int,bigint>")))
        .select("table_name", "table_text", dense.alias("vec"))
        .withColumn("vec", unit(F.col("vec")))
    )


def model_encoder(load_model: Callable[[], object]) -> Encoder:
    """E4 with a sentence model: `load_model()` runs once per Python worker and returns an object
    with `encode(list_of_texts) -> 2-d array`; batches reach it through Arrow."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in model.encode(batch.tolist())], index=batch.index)

    def encoder(texts: DataFrame) -> DataFrame:
        return texts.withColumn("vec", encode("table_text")).withColumn("vec", unit(F.col("vec")))

    return encoder


def vector_of(embeddings: DataFrame, name: str) -> list[float]:
    """The stored vector of one table."""
    row = embeddings.where(F.col("table_name") == name).select("vec").head()
    if row is None:
        raise KeyError(f"no vector is stored for {name}")
    return list(row["vec"])


def nearest(embeddings: DataFrame, query_vec: list[float], top_k: int) -> DataFrame:
    """Exact top-k by cosine, one scan with a bounded heap per task."""
    score = cosine(F.col("vec"), vector_literal(query_vec))
    return (
        embeddings.select("table_name", score.alias("score"))
        .orderBy(F.col("score").desc(), "table_name").limit(top_k)
    )


# Bits of the signatures made in Python workers.
SEARCH_BITS = 512
# Chance that a row as near as the bound lies within the radius of signatures.
RECALL = 0.9
_QUERIES_AT_ONCE = 64


def radius_of(bound: float, bits: int, recall: float) -> int:
    """Bits in which the signatures of two unit vectors with at least this cosine differ at most, with a chance of `recall`.

    Each bit differs with probability angle / pi, so the number is binomial; all rows are within the radius of a bound of 0.
    """
    if bound <= 0:
        return bits
    share = math.acos(min(1.0, bound)) / math.pi
    return min(bits, math.ceil(bits * share + NormalDist().inv_cdf(recall) * math.sqrt(bits * share * (1 - share))))


def plane_sign(bit: int, dimension: int) -> int:
    """One coordinate of a random plane: 1 or -1, by the first hexadecimal digit of an md5."""
    return 1 if hashlib.md5(f"{bit},{dimension}".encode()).hexdigest()[0] < "8" else -1


def nearest_approx(embeddings: DataFrame, query_vec: list[float], top_k: int, recall: float = RECALL) -> DataFrame:
    """E8 for one query, without an index: the `top_k` rows whose signatures differ least bound the k-th best score, and all rows within the radius
    that follows from it (see `radius_of`) are ranked by exact cosine. `VectorIndex` serves many queries.

    There are always `top_k` rows if there are as many.
    """
    found = _within_radius(embeddings, ["query"], np.array([query_vec], float), top_k, recall)
    return found.select("table_name", "score").orderBy(F.col("score").desc(), "table_name").limit(top_k)


_FOUND = "query string, table_name string, score double, apart int"


class _Search:
    """Nearest rows for many queries at once; every task holds the queries and `top_k` rows for each of them.

    `radius`: bits that signatures may differ at most, for each query; None compares all rows. `by_apart` takes the rows whose signatures
    differ least instead of those with the best score.
    """

    def __init__(self, names: list[str], vecs: np.ndarray, top_k: int, radius: np.ndarray | None = None, by_apart: bool = False):
        self.names, self.vecs, self.top_k, self.radius, self.by_apart = names, vecs, top_k, radius, by_apart
        self.planes = None
        if radius is not None or by_apart:
            self.planes = np.array([[plane_sign(b, i) for b in range(SEARCH_BITS)] for i in range(vecs.shape[1])], float)

    def _signatures(self, vecs: np.ndarray) -> np.ndarray:
        return np.packbits(vecs @ self.planes > 0, axis=1).view(np.uint64)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in self.names]
        own = None if self.planes is None else self._signatures(self.vecs)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.array(batch.column(0).to_pylist(), object)
            vecs = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(names), -1)
            signatures = None if own is None else self._signatures(vecs)
            for at in range(0, len(self.names), _QUERIES_AT_ONCE):
                some = slice(at, at + _QUERIES_AT_ONCE)
                if own is not None:
                    apart = np.zeros((len(self.names[some]), len(names)), np.int64)
                    for j in range(own.shape[1]):
                        apart += np.bitwise_count(own[some, j, None] ^ signatures[None, :, j])
                for q in range(at, min(at + _QUERIES_AT_ONCE, len(self.names))):
                    d = np.zeros(len(names), np.int64) if own is None else apart[q - at]
                    rows = np.arange(len(names)) if self.radius is None else np.flatnonzero(d <= self.radius[q])
                    if self.by_apart and len(rows) > self.top_k:
                        rows = rows[d[rows] <= np.partition(d[rows], self.top_k - 1)[self.top_k - 1]]
                    # Equal vectors get equal scores wherever they stand in a batch, so ties are settled by name.
                    scores = np.maximum(np.einsum("ij,j->i", vecs[rows], self.vecs[q]), 0.0)
                    if not self.by_apart and len(rows) > self.top_k:
                        enough = scores >= np.partition(scores, len(rows) - self.top_k)[len(rows) - self.top_k]
                        rows, scores = rows[enough], scores[enough]
                    found = best[q] + list(zip(d[rows].tolist() if self.by_apart else (-scores).tolist(), names[rows].tolist(), scores.tolist(), d[rows].tolist()))
                    best[q] = sorted(found)[: self.top_k]
        rows = [(q, name, score, d) for q, found in zip(self.names, best) for _, name, score, d in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int32())],
            names=["query", "table_name", "score", "apart"])


def _first(found: DataFrame, top_k: int, *order: Column | str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order, "table_name"))
    return found.withColumn("rank", place).where(F.col("rank") <= top_k)


def _within_radius(embeddings: DataFrame, names: list[str], vecs: np.ndarray, top_k: int, recall: float) -> DataFrame:
    index = embeddings.select("table_name", "vec")
    first = _first(index.mapInArrow(_Search(names, vecs, top_k, by_apart=True), _FOUND), top_k, "apart")
    bounds = {
        r["query"]: max(radius_of(r["bound"] if r["n"] >= top_k else 0.0, SEARCH_BITS, recall), r["apart"])
        for r in first.groupBy("query").agg(F.min("score").alias("bound"), F.max("apart").alias("apart"), F.count("*").alias("n")).collect()}
    radius = np.array([bounds.get(name, SEARCH_BITS) for name in names])
    found = index.mapInArrow(_Search(names, vecs, top_k, radius), _FOUND)
    return _first(found, top_k, F.col("score").desc()).drop("apart")
