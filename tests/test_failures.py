"""A table that cannot be read is told of; what is left of the others is no result."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablescout import TableSource, build_lake
from tablescout.plans.oracles import SCHEMAS
from tablescout.plans.profiling import export_profiles
from tablescout.plans.registry import QUERIES
from tablescout.plans.testlake import RAW_TABLES

UNREADABLE = (PySparkException, Py4JJavaError)


def write_table(spark, folder, name, damaged=False):
    """A small table of its schema. If damaged, its footer stays, so that it opens, but its data cannot be read."""
    parts = [p.split() for p in SCHEMAS[name].split(",")]
    df = spark.range(12).select(*[
        F.array(F.col("id").cast("float")).alias("embedding") if kind == "nested" else F.expr(
            f"timestamp_ntz'2024-01-01 00:00:00' + id * interval 1 hour as {c}" if kind == "timestamp_ntz" else f"cast(id as {kind}) as {c}")
        for c, kind in parts])
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    if damaged:
        file = next((folder / f"{name}.parquet").glob("part-*.parquet"))
        raw = file.read_bytes()
        file.write_bytes(raw[:4] + b"\xff" * (len(raw) // 3) + raw[4 + len(raw) // 3 :])
        for crc in (folder / f"{name}.parquet").glob(".*.crc"):
            crc.unlink()


@pytest.fixture(scope="module")
def damaged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    for name in RAW_TABLES:
        write_table(spark, folder, name, damaged=name == "events")
    return folder


def test_profiles_are_not_exported_without_a_table(spark, damaged, tmp_path):
    source = TableSource({t: spark.read.parquet(f"{damaged}/{t}.parquet") for t in ("nation", "events")})
    with pytest.raises(UNREADABLE):
        export_profiles(source, str(tmp_path / "p"))
    assert not (tmp_path / "p").exists()
    # A lake tells which tables it left out, and why.
    lake = build_lake(source, str(tmp_path / "lake"), "L")
    assert lake.meta["skipped"] == ["events"] and lake.meta["skip_reasons"][0].startswith("events: ")


def test_exported_typed_profiles_need_all_tables(spark, damaged):
    with pytest.raises(UNREADABLE):
        QUERIES["exported_typed_profiles"](spark, str(damaged)).collect()


def test_zscores_are_not_of_some_tables(spark, damaged):
    with pytest.raises(UNREADABLE):
        QUERIES["zscored_profiles"](spark, str(damaged)).collect()
    # What failed is not kept as the profile of that folder.
    with pytest.raises(UNREADABLE):
        QUERIES["zscored_profiles"](spark, str(damaged)).collect()
