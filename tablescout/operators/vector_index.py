"""E7 and E8 for many queries at once: blocks of all rows, and a stored index of cells.

The index deals all rows out to cells several times, by as many sets of trained centroids. A query meets the rows of
the one cell of each set that it lies in. Where one clustering would have to be probed in many cells (nearest
neighbours in many dimensions lie on either side of most borders), several independent ones find them with few rows: a neighbour
is lost only if all of them part it from the query. Sets are added until a sample's searches reach the recall asked for; where the
most sets do not, a query meets several cells of each. The sample's searches are among rows that no centroid was trained on.

Queries and rows meet in an equi-join on lists. A list is a part of a cell of bounded size, so a hot cell is many lists; the stored
table is bucketed by list, so that a search does not shuffle it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescout.workspace import materialize

# Rows of a list, and queries that meet a list in one task.
LIST_ROWS = 1 << 14
QUERY_ROWS = 1 << 12

# Bounds of the training: rows that centroids are trained on (and as many that judge them), queries, cells of a set, and sets.
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 400
MAX_CELLS = 4_096
MAX_SETS = 32

RECALL = 0.9
# Sets are added until the sample's recall is this much above the one asked for.
MARGIN = 0.02

_FOUND = "query string, table_name string, score double"


def _matrix(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimensions)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _meet(top_k: int, dimensions: int):
    """The `top_k` best rows of a list for each of its queries, ties by name."""
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table({"query": pa.array([], pa.string()), "table_name": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        asked, vecs = queries.column("query").to_pylist(), _matrix(queries.column("qvec"), dimensions)
        names, held = np.array(rows.column("table_name").to_pylist(), object), _matrix(rows.column("vec"), dimensions)
        out = []
        for name, vec in zip(asked, vecs):
            # Row by row, so that equal vectors score alike wherever they stand.
            scores = np.maximum(np.einsum("ij,j->i", held, vec), 0.0)
            best = np.arange(len(scores))
            if len(scores) > top_k:
                best = np.flatnonzero(scores >= np.partition(scores, len(scores) - top_k)[len(scores) - top_k])
            best = sorted(best.tolist(), key=lambda i: (-scores[i], names[i]))[:top_k]
            out.append((np.full(len(best), name, object), names[best], scores[best]))
        return pa.table({
            "query": pa.array(np.concatenate([o[0] for o in out]), pa.string()),
            "table_name": pa.array(np.concatenate([o[1] for o in out]), pa.string()), "score": np.concatenate([o[2] for o in out])})

    return run


def _dimensions(embeddings: DataFrame) -> int:
    row = embeddings.select(F.size("vec")).head()
    return row[0] if row else 0


def _ranked(found: DataFrame, top_k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "table_name"))
    return found.withColumn("rank", place).where(F.col("rank") <= top_k)


def _dealt(queries: DataFrame, lists: Column) -> DataFrame:
    """Queries with the lists they meet: (query, qvec, list)."""
    return queries.select(F.col("table_name").alias("query"), F.col("vec").alias("qvec"), F.explode(lists).alias("list"))


def nearest_each(embeddings: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """E7 for each of `queries` (rows like those of `embeddings`): query, table_name, score, rank. Exact.

    Rows and queries are dealt out in blocks; each block of rows meets each block of queries once.
    """
    blocks, parts = max(-(-embeddings.count() // LIST_ROWS), 1), max(-(-queries.count() // QUERY_ROWS), 1)
    asked = _dealt(queries, F.sequence(F.lit(0), F.lit(blocks - 1))).withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)))
    block = F.pmod(F.xxhash64("table_name"), F.lit(blocks)).cast("int")
    rows = embeddings.select("table_name", "vec", block.alias("list"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    met = asked.groupBy("list", "part").cogroup(rows.groupBy("list", "part")).applyInArrow(_meet(top_k, _dimensions(embeddings)), _FOUND)
    return _ranked(met, top_k)


def train_cells(sample: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a spherical k-means over unit vectors; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        own = nearest_cell(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        filled = np.linalg.norm(sums, axis=1) > 0
        centroids = np.where(filled[:, None], _unit(sums), centroids)
    return centroids


def nearest_cell(x: np.ndarray, centroids: np.ndarray, at_once: int = 4_096) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *((x[i : i + at_once] @ centroids.T).argmax(axis=1) for i in range(0, len(x), at_once))])


def nearest_cells(x: np.ndarray, centroids: np.ndarray, probes: int, at_once: int = 4_096) -> np.ndarray:
    """The numbers of the `probes` nearest cells of each row."""
    if probes == 1:
        return nearest_cell(x, centroids, at_once)[:, None]
    found = [np.argpartition(-(x[i : i + at_once] @ centroids.T), probes - 1, axis=1)[:, :probes] for i in range(0, len(x), at_once)]
    return np.concatenate([np.zeros((0, probes), np.int64), *found])


class Cells:
    """Sets of centroids, and the lists of every cell: those of cell c of set s are first[s][c] to first[s][c] + count[s][c].

    A query meets the `probes` nearest cells of each set."""

    def __init__(self, centroids: list[np.ndarray], counts: list[np.ndarray], sample_recall: float, probes: int = 1) -> None:
        self.centroids, self.counts, self.sample_recall, self.probes = centroids, counts, sample_recall, probes
        ends = np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.first, at = [], 0
        for c in counts:
            self.first.append(starts[at : at + len(c)])
            at += len(c)

    @property
    def lists(self) -> int:
        return int(sum(c.sum() for c in self.counts))

    def to_json(self) -> str:
        return json.dumps({
            "centroids": [c.tolist() for c in self.centroids], "counts": [c.tolist() for c in self.counts], "sample_recall": self.sample_recall,
            "probes": self.probes})

    @staticmethod
    def from_json(text: str) -> Cells:
        d = json.loads(text)
        return Cells([np.array(c) for c in d["centroids"]], [np.array(c, np.int64) for c in d["counts"]], d["sample_recall"], d.get("probes", 1))


def fit_cells(embeddings: DataFrame, recall: float = RECALL, top_k: int = 10, seed: int = 5) -> Cells:
    """Train on a bounded sample: SAMPLE_ROWS rows chosen by a hash of their names.

    Sets are added, then cells that a query meets, until the searches of SAMPLE_QUERIES rows find `recall` plus MARGIN of their `top_k` nearest
    rows. Centroids lie close to the rows they were trained on, which share cells more often than others. So the searches are
    among SAMPLE_ROWS other rows, or among all rows where these are no more than both parts. The whole table's nearest
    rows are nearer than the sample's, so they are parted less often.
    """
    total = embeddings.count()
    rows = embeddings.select("vec", F.xxhash64("table_name").alias("h"), "table_name").orderBy("h", "table_name").limit(2 * SAMPLE_ROWS).select("vec").toArrow()
    if not rows.num_rows:
        return Cells([], [], 1.0)
    vecs = rows.column("vec").combine_chunks()
    drawn = _unit(_matrix(vecs, len(vecs[0])))
    sample = drawn[:SAMPLE_ROWS]
    judged = drawn if total <= len(drawn) else drawn[SAMPLE_ROWS:]
    cells = max(1, min(int(2 * total**0.5), MAX_CELLS, len(sample) // 5))
    # Where trained rows and others are judged together, queries are drawn evenly from both.
    at = np.arange(0, len(judged), len(judged) // SAMPLE_QUERIES if SAMPLE_ROWS < total == len(judged) else 1)[:SAMPLE_QUERIES]
    asked = judged[at]
    scores = asked @ judged.T
    k = min(top_k, len(judged))
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    # How many cells of a set a query has to meet to find a row, in the best set.
    needed, centroids, counts, share = np.full(best.shape, cells), [], [], 0.0
    goal = min(1.0, recall + MARGIN)
    while len(centroids) < MAX_SETS and share < goal:
        trained = train_cells(sample, cells, seed + len(centroids))
        near = asked @ trained.T
        held = np.take_along_axis(near, nearest_cell(judged, trained)[best], axis=1)
        needed = np.minimum(needed, 1 + np.array([(n > h[:, None]).sum(axis=1) for n, h in zip(near, held)]))
        share = float((needed <= 1).mean())
        centroids.append(trained)
        # Lists by the cell's share of the sample; rows are dealt to them by a hash.
        own = nearest_cell(sample, trained)
        counts.append(np.ceil(np.bincount(own, minlength=cells) * (total / len(sample)) / LIST_ROWS).clip(1).astype(np.int64))
    probes = next(p for p in range(1, cells + 1) if (needed <= p).mean() >= goal or p == cells)
    return Cells(centroids, counts, float((needed <= probes).mean()), probes)


class VectorIndex:
    """A stored table (list, table_name, vec), bucketed by list, and its cells."""

    def __init__(self, table: DataFrame, cells: Cells) -> None:
        self.table, self.cells = table, cells

    @staticmethod
    def build(embeddings: DataFrame, path: str, recall: float = RECALL, top_k: int = 10, buckets: int | None = None) -> VectorIndex:
        """Write the index of `embeddings` (table_name, vec) below `path`. Every row is in one list of every set.

        Null vectors and vectors of zeros are rows like any other (a null is left out; zeros have score 0 with all).
        """
        spark = embeddings.sparkSession
        rows = embeddings.select("table_name", "vec").where("vec is not null")
        cells = fit_cells(rows, recall, top_k)
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = _listed(rows, cells, "table_name string, vec array<double>, list int", every=False)
        dealt.repartition(buckets, "list").write.bucketBy(buckets, "list").sortBy("list").option("path", f"{path}/lists").saveAsTable(_name(path))
        meta = spark.createDataFrame([(cells.to_json(), buckets)], "cells string, buckets int")
        meta.write.parquet(f"{path}/cells")
        return VectorIndex(spark.table(_name(path)), cells)

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        """An index that any session has built."""
        meta = spark.read.parquet(f"{path}/cells").first()
        name = _name(path)
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"create table {name} (table_name string, vec array<double>, list int) using parquet"
                f" clustered by (list) sorted by (list) into {meta['buckets']} buckets location '{path}/lists'")
        return VectorIndex(spark.table(name), Cells.from_json(meta["cells"]))

    def nearest_each(self, queries: DataFrame, top_k: int) -> DataFrame:
        """query, table_name, score, rank for each of `queries`: the best of the rows in the query's cells, ties by name.

        A query whose cells hold fewer than `top_k` rows is compared with all rows. The queries of a cell are held by the tasks that
        read its lists.
        """
        queries = queries.select("table_name", "vec").where("vec is not null")
        if not self.cells.centroids:
            return queries.sparkSession.createDataFrame([], f"{_FOUND}, rank int")
        asked = _listed(queries, self.cells, "query string, qvec array<double>, list int", every=True)
        met = materialize(self._meet(asked, top_k).dropDuplicates(["query", "table_name"]), "neighbours")
        total = self.table.where(f"list < {int(self.cells.counts[0].sum())}").count()
        enough = met.groupBy("query").count().where(F.col("count") >= min(top_k, total))
        few = queries.join(enough.select(F.col("query").alias("table_name")), "table_name", "left_anti")
        # Every row is in one list of the first set.
        all_lists = _dealt(few, F.sequence(F.lit(0), F.lit(int(self.cells.counts[0].sum()) - 1)))
        found = met.join(enough.select("query"), "query", "left_semi").unionByName(self._meet(all_lists, top_k))
        return _ranked(found, top_k)

    def _meet(self, asked: DataFrame, top_k: int) -> DataFrame:
        return asked.groupBy("list").cogroup(self.table.groupBy("list")).applyInArrow(_meet(top_k, self.cells.centroids[0].shape[1]), _FOUND)

    def rows_met(self, queries: DataFrame) -> DataFrame:
        """(query, rows): how many rows of the index a query is compared with, each counted once."""
        asked = _listed(queries.select("table_name", "vec"), self.cells, "query string, qvec array<double>, list int", every=True)
        return asked.drop("qvec").join(self.table.select("list", "table_name"), "list").distinct().groupBy("query").agg(
            F.countDistinct("table_name").alias("rows"))


def _name(path: str) -> str:
    return "vector_lists_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex


def _listed(rows: DataFrame, cells: Cells, schema: str, every: bool) -> DataFrame:
    """Rows with the lists of their cells: one list a cell by a hash of the name, or every list of it."""
    names = [part.split()[0] for part in schema.split(", ")]
    dimensions = cells.centroids[0].shape[1] if cells.centroids else 1
    hashed = rows.select("table_name", F.col("vec").cast("array<double>").alias("vec"), F.xxhash64("table_name").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1), dimensions))
            h = batch.column(2).to_numpy().astype(np.uint64)
            for centroids, first, count in zip(cells.centroids, cells.first, cells.counts):
                if every:
                    cell = nearest_cells(unit, centroids, cells.probes)
                    rows_of, cell = np.repeat(np.arange(len(cell)), cells.probes), cell.ravel()
                    at = np.repeat(np.arange(len(cell)), count[cell])
                    place = np.arange(len(at)) - np.repeat(np.cumsum(count[cell]) - count[cell], count[cell])
                    at, lists = rows_of[at], first[cell][at] + place
                else:
                    cell = nearest_cell(unit, centroids)
                    at, lists = np.arange(len(cell)), first[cell] + (h % count[cell].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(lists, pa.int32())], names=names)

    return hashed.mapInArrow(run, schema)
