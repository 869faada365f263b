"""Nearest rows of many queries: exact blocks and the stored index of cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.operators import vector_index as V
from tablescout.plans.registry import _every_fiftieth, _vectors


def frame(spark, vecs, names=None):
    rows = [(str(i) if names is None else names[i], list(map(float, v))) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "table_name string, vec array<double>")


def brute(vecs, queries, k):
    scores = np.maximum(vecs @ vecs.T, 0)
    return {(str(q), r + 1): (str(i), round(scores[q, i], 9)) for q in queries
            for r, i in enumerate(sorted(range(len(vecs)), key=lambda i: (-scores[q, i], str(i)))[:k])}


def shown(df):
    return {(r["query"], r["rank"]): (r["table_name"], round(r["score"], 9)) for r in df.collect()}


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(V, "LIST_ROWS", 40)
    monkeypatch.setattr(V, "QUERY_ROWS", 7)
    vecs = np.round(4 * unit(np.random.default_rng(1), 150, 8))
    vecs[60:80] = vecs[3]
    df = frame(spark, vecs)
    asked = range(0, 150, 5)
    assert shown(V.nearest_each(df, df.where(F.col("table_name") % 5 == 0), 6)) == brute(vecs, asked, 6)
    assert V.nearest_each(df, df.limit(0), 6).count() == 0 and V.nearest_each(df.limit(0), df, 6).count() == 0


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_rows_touched(spark, sf_dir, tmp_path):
    index = _vectors(spark, sf_dir)
    asked = _every_fiftieth(index)
    built = V.VectorIndex.build(index, f"{tmp_path}/index")
    exact = V.nearest_each(index, asked, 10).select("query", "table_name").toPandas()
    found = built.nearest_each(asked, 10).select("query", "table_name").toPandas()
    assert len(exact) == len(found) == 10 * asked.count()
    recall = len(exact.merge(found)) / len(exact)
    rows = index.count()
    touched = built.rows_met(asked).agg(F.avg("rows")).first()[0] / rows
    print(sf_dir, "recall", recall, "rows touched", touched, "sets", len(built.cells.centroids), "recall of the sample", built.cells.sample_recall)
    assert recall >= 0.9
    if rows >= 2000:
        assert touched <= 0.15
    # Every row lies in one list of every set.
    assert built.table.count() == rows * len(built.cells.centroids)


def test_index_is_stored_and_not_shuffled(spark, tmp_path):
    vecs = unit(np.random.default_rng(2), 400, 8)
    df = frame(spark, vecs)
    path = f"{tmp_path}/index"
    built = V.VectorIndex.build(df, path, top_k=5)
    asked = df.where(F.col("table_name") % 20 == 0)
    before = shown(built.nearest_each(asked, 5))
    spark.sql(f"drop table {V._name(path)}")
    loaded = V.VectorIndex.load(spark, path)
    assert shown(loaded.nearest_each(asked, 5)) == before
    listed = V._listed(asked.select("table_name", "vec"), loaded.cells, "query string, qvec array<double>, list int", every=True)
    plan = loaded._meet(listed, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_hot_cells_and_odd_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(V, "LIST_ROWS", 25)
    vecs = unit(np.random.default_rng(3), 240, 6)
    vecs[100:200] = vecs[7]
    vecs[5] = 0
    df = frame(spark, vecs).unionByName(spark.createDataFrame([("none", None)], "table_name string, vec array<double>"))
    built = V.VectorIndex.build(df, f"{tmp_path}/index")
    assert max(int(c.max()) for c in built.cells.counts) >= 4
    asked = df.where("table_name in ('7', '100', '5', 'none')")
    found = shown(built.nearest_each(asked, 10))
    expected = brute(vecs, [7, 100, 5], 10)
    assert {k: v for k, v in found.items() if k[0] != "5"} == {k: v for k, v in expected.items() if k[0] != "5"}
    assert sum(k[0] == "5" for k in found) == 10 and all(v[1] == 0 for k, v in found.items() if k[0] == "5")


def test_fewer_rows_than_asked_for(spark, tmp_path):
    vecs = unit(np.random.default_rng(4), 7, 3)
    df = frame(spark, vecs)
    assert shown(V.VectorIndex.build(df, f"{tmp_path}/small").nearest_each(df, 10)) == brute(vecs, range(7), 10)
    empty = V.VectorIndex.build(df.limit(0), f"{tmp_path}/empty")
    assert empty.nearest_each(df, 10).count() == 0


def test_recall_beyond_the_sample(spark, monkeypatch, tmp_path):
    """Most rows are not in the sample that centroids are trained on."""
    monkeypatch.setattr(V, "SAMPLE_ROWS", 500)
    vecs = unit(np.random.default_rng(3), 4000, 24)
    df = frame(spark, vecs)
    asked = df.where(F.col("table_name") % 50 == 0)
    built = V.VectorIndex.build(df, f"{tmp_path}/index")
    found = shown(built.nearest_each(asked, 10))
    exact = brute(vecs, range(0, 4000, 50), 10)
    neighbours = {(q, name) for (q, _), (name, _) in found.items()}
    assert sum((q, name) in neighbours for (q, _), (name, _) in exact.items()) >= 0.9 * len(exact)
    assert built.cells.probes > 1 and V.VectorIndex.load(spark, f"{tmp_path}/index").cells.probes == built.cells.probes
