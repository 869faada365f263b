"""Invariants and accuracy of the sketches."""

import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescout import TableSource, profile
from tablescout.functions.scores import containment
from tablescout.operators.sketch import minhash

VALUES = st.lists(st.integers(0, 400).map(str), min_size=1, max_size=300)


def sketches(spark, *columns):
    source = TableSource({
        f"t{i}": spark.createDataFrame([(v,) for v in values], "v string") for i, values in enumerate(columns)
    })
    prof = profile(source)
    named = minhash(prof.raw_counts).join(prof.columns, "column_id")
    return {r["table_name"]: (r["sig"], r["n"]) for r in named.collect()}


def estimate(spark, a, b):
    df = spark.createDataFrame([(a[0], a[1], b[0], b[1])], "a array<string>, na bigint, b array<string>, nb bigint")
    return df.select(containment(F.col("a"), F.col("na"), F.col("b"), F.col("nb")).alias("x")).head()["x"]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(a=VALUES, b=VALUES)
def test_invariants(spark, a, b):
    got = sketches(spark, a, [*reversed(a), *a], b, a + b)
    assert got["t0"] == got["t1"]
    merged = sorted({*got["t0"][0], *got["t2"][0]})[:128]
    assert got["t3"] == (merged, len({*a, *b}))
    forth, back = estimate(spark, got["t0"], got["t2"]), estimate(spark, got["t2"], got["t0"])
    assert forth == pytest.approx(back) and 0.0 <= forth <= 1.0
    assert estimate(spark, got["t0"], got["t0"]) == 1.0


def test_accuracy(spark):
    """Mean error against true containment of large columns that overlap more and more."""
    base = [f"v{i}" for i in range(1000)]
    overlaps = [0.1, 0.3, 0.5, 0.7, 0.9]
    columns = [base, *[[f"v{i}" for i in range(int(1000 * (1 - o)), int(1000 * (2 - o)))] for o in overlaps]]
    got = sketches(spark, *columns)
    errors = [abs(estimate(spark, got["t0"], got[f"t{i + 1}"]) - o) for i, o in enumerate(overlaps)]
    assert statistics.mean(errors) <= 0.1
