"""The catalog and the workspace: what they refuse, what they keep and what they clean up."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tablescout import TableSource, build_lake
from tablescout import workspace as w
from tablescout.functions.text import soundex
from tablescout.operators.embedding import hashing_encoder


def small_source(spark):
    return TableSource({
        "a": spark.createDataFrame([("x1", 1), ("x2", 2), ("x3", 3)], "code string, n int"),
        "b": spark.createDataFrame([("x1",), ("x2",)], "key string"),
    })


def test_vectors_of_another_encoder_are_refused(spark, tmp_path):
    def short_encoder(texts):
        return hashing_encoder(texts, 16)

    lake = build_lake(small_source(spark), str(tmp_path / "lake"), "small", encoder=short_encoder)
    assert (lake.meta["dimensions"], lake.meta["encoder"].split(".")[-1]) == (16, "short_encoder")
    query = spark.createDataFrame([("x1", 5)], "code string, n int")
    with pytest.raises(ValueError, match="short_encoder"):
        lake.search(query)

    def wrong_size(texts):
        return hashing_encoder(texts, 8)

    wrong_size.name = lake.meta["encoder"]
    with pytest.raises(ValueError, match="8"):
        lake.search(query, encoder=wrong_size)
    assert lake.search(query, encoder=short_encoder).count() == 2


def test_no_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError, match=w.CHECKPOINT_CONF):
            w.shared_dir(session)


def test_cleanup_deletes_what_was_written(spark):
    import os

    kept = dict(w._written)
    w._written.clear()
    try:
        df = w.materialize(spark.range(10), "mine")
        folder = w._written[spark.sparkContext.applicationId][0]
        assert df.count() == 10 and os.path.isdir(folder.removeprefix("file:"))
        other = w.materialize(df, "other")
        w.drop_written(other.filter("id > 1"))
        assert other.count() == 10
        w.drop_written(other)
        assert df.count() == 10 and w._written[spark.sparkContext.applicationId] == [folder]
        w.cleanup(spark)
        assert not os.path.exists(folder.removeprefix("file:"))
    finally:
        w._written.update(kept)


CODES = {
    "Robert": "R163", "Rupert": "R163", "Rubin": "R150", "Ashcraft": "A261", "Ashcroft": "A261", "Tymczak": "T522", "Pfister": "P236",
    "Honeyman": "H555", "123": "1000", "5-low": "5400", "": "", "a": "A000", " b": " 100", "BBB": "B000", "1b1b": "1110", "Wright": "W623", "é": "é000",
}


def test_soundex(spark):
    df = spark.createDataFrame(list(CODES.items()), "v string, code string")
    assert {r["v"]: r["c"] for r in df.select("v", soundex(F.col("v")).alias("c")).collect()} == CODES
