"""Hand-worked cases for the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from tablescout.functions import scores as s
from tablescout.functions import text as t


def value(spark, column, **literals):
    df = spark.range(1)
    for name, v in literals.items():
        df = df.withColumn(name, F.lit(v))
    return df.select(column.alias("x")).head()["x"]


def values(spark, column, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r["x"] for r in df.orderBy("_i").select(column.alias("x")).collect()]


def test_type_class(spark):
    names = ["BIGINT", "int", "smallint", "double", "decimal(10,2)", "VARCHAR", "string", "boolean", "DATE",
             "timestamp_ntz", "TIME", "INTERVAL", "INTEGER[]", "UUID"]
    want = ["numeric"] * 5 + ["string"] * 3 + ["date"] * 3 + ["numeric", "numeric", "string"]
    assert values(spark, t.type_class(F.col("n")), [(n,) for n in names], "n string") == want
    assert [t.type_class_of(n) for n in names] == want


def test_cleaning_domains(spark):
    rows = [("  AbC ",), ("abc \n",), ("a\nb",), ("\tx",), ("   ",), (None,)]
    assert values(spark, t.clean_value(F.col("v")), rows, "v string") == ["abc", "abc ", "ab", "\tx", "", None]
    assert values(spark, t.normalise_value(F.col("v")), rows, "v string") == ["abc", "abc", "a\nb", "x", "", None]


def test_column_names():
    assert t.clean_column_names(['﻿"a"', " b\r\n", "A", "c d"]) == ["a", "b", "A_1", "c d"]


def test_name_tokens(spark):
    assert value(spark, t.name_tokens(F.col("n")), n="Customer_ID2x") == ["customer", "id", "x"]


def test_tolerant_numbers(spark):
    rows = [("1.5",), ("abc",), (None,), ("NaN",)]
    assert values(spark, t.number_or(F.col("v"), 7), rows, "v string") == [1.5, 7.0, 7.0, 7.0]
    assert values(spark, t.integer_or(F.col("v"), 7), rows, "v string") == [1, 7, 7, 7]


def test_double_text(spark):
    from pyspark.sql import types as T

    rows = [(1.0,), (123456789.5,), (1e7,), (0.00012,), (-0.5,), (-1.25e8,)]
    got = values(spark, F.expr(t.text_sql("v", T.DoubleType())), rows, "v double")
    assert got == ["1.0", "123456789.5", "10000000.0", "0.00012", "-0.5", "-125000000.0"]


def test_word_stats(spark):
    df = spark.createDataFrame([("a  b",), ("",), (None,)], "v string")
    row, empty, missing = t.with_word_stats(df, "v").collect()
    assert (row["words"], row["w_min"], row["w_max"]) == (3, 0, 1)
    assert row["w_avg"] == pytest.approx(2 / 3)
    assert (empty["words"], empty["w_min"], empty["w_max"], empty["w_avg"]) == (1, 0, 0, 0.0)
    assert missing["words"] is None and missing["w_max"] is None


def test_buckets(spark):
    rows = [(0.0,), (0.1,), (0.1001,), (0.5,), (0.9,), (0.91,), (1.0,)]
    assert values(spark, s.cardinality_bucket(F.col("r")), rows, "r double") == [0, 0, 1, 1, 2, 3, 3]
    rows = [(5.0,), (5.1,), (30.0,), (30.1,)]
    assert values(spark, s.length_bucket(F.col("r")), rows, "r double") == [0, 1, 1, 2]


ROLE_CASES = [
    ("date", 0, 0.5, 5, 10, 0.1, 1, 2, 1.0, 1.0, "TEMPORAL"),
    ("numeric", 1, 0.02, 2, 100, 0.5, 1, 1, 1.0, 1.0, "FLAG"),
    ("string", 1, 1.0, 2, 2, 0.5, 3, 3, 3.0, 1.0, "FLAG"),
    ("numeric", 0, 0.96, 96, 100, 0.02, 1, 2, 2.0, 1.0, "IDENTIFIER"),
    ("numeric", 0, 0.95, 95, 100, 0.02, 1, 2, 2.0, 1.0, "MEASURE"),
    ("numeric", 0, 0.049, 49, 1000, 0.05, 1, 2, 2.0, 1.0, "CATEGORY"),
    ("numeric", 0, 0.05, 50, 1000, 0.05, 1, 2, 2.0, 1.0, "MEASURE"),
    ("string", 0, 1.0, 100, 100, 0.01, 1, 9, 5.0, 3.0, "JOIN_CODE"),
    ("string", 0, 1.0, 100, 100, 0.01, 1, 9, 5.0, 3.5, "FREE_TEXT"),
    ("string", 0, 0.05, 50, 1000, 0.9, 2, 2, 2.0, 1.0, "JOIN_CODE"),
    ("string", 0, 0.099, 99, 1000, 0.05, 2, 8, 5.0, 1.0, "CATEGORY"),
    ("string", 0, 0.1, 100, 1000, 0.05, 2, 8, 5.0, 1.0, "FOREIGN_KEY_CANDIDATE"),
    ("string", 0, 0.5, 500, 1000, 0.05, 2, 80, 31.0, 1.0, "FREE_TEXT"),
    ("string", 0, None, None, 0, None, None, None, None, None, "CATEGORY"),
]


def test_roles(spark):
    schema = ("tc string, b int, u double, card bigint, r bigint, top double, lmin bigint, lmax bigint,"
              " lavg double, w double, want string")
    c = F.col
    role = s.classify(c("tc"), c("b"), c("u"), c("card"), c("r"), c("top"), c("lmin"), c("lmax"), c("lavg"), c("w"))
    assert values(spark, role, ROLE_CASES, schema) == [case[-1] for case in ROLE_CASES]


def test_containment_of_small_sets(spark):
    rows = [
        (["1", "2", "3", "4"], 4, ["3", "4", "5", "6"], 4),
        (["1", "2"], 2, ["1", "2", "3", "4"], 4),
        (["1", "2"], 2, ["3"], 1),
        ([], 0, ["1"], 1),
    ]
    schema = "a array<string>, na bigint, b array<string>, nb bigint"
    got = values(spark, s.containment(F.col("a"), F.col("na"), F.col("b"), F.col("nb")), rows, schema)
    assert got == pytest.approx([0.5, 1.0, 0.0, 0.0])


def test_length_compat_and_prior(spark):
    rows = [(2, 2, 2, 2), (2, 2, 3, 3), (2, 2, 2, 5), (4, 32, 4, 18), (5, 7, 5, 8), (None, None, 2, 5), (5, 2, 1, 2)]
    schema = "a1 int, a2 int, b1 int, b2 int"
    args = [F.col(c) for c in ("a1", "a2", "b1", "b2")]
    got = values(spark, s.length_compat(*args), rows, schema)
    assert got == pytest.approx([1.0, 0.5, 0.5, 0.75, 0.5 + 1 / 3, 1.0, 1.0])
    mixed = s.joinable_prior(F.lit("string"), F.lit(2), F.lit(2), F.lit("numeric"), F.lit(2), F.lit(2))
    assert value(spark, mixed) == pytest.approx(0.7)


def test_noisy_or_and_similarity(spark):
    assert value(spark, s.noisy_or(F.array(F.lit(0.5), F.lit(0.5)))) == pytest.approx(0.75)
    assert value(spark, s.noisy_or(F.array(F.lit(0.9), F.lit(0.8), F.lit(0.5)))) == pytest.approx(0.99)
    assert value(spark, s.noisy_or(F.array().cast("array<double>"))) == 0.0
    block = s.similarity_block(F.lit(0.8), F.lit(0.6))
    assert value(spark, s.similarity(F.lit(0.5), block)) == pytest.approx(math.sqrt(0.37))
    assert value(spark, s.similarity(F.lit(0.0), block)) == 0.0


def test_structural_vector(spark):
    from tablescout.operators.table_profile import structural_vector

    def vector(*hists):
        return value(spark, structural_vector(*[F.array(*[F.lit(x).cast("bigint") for x in h]) for h in hists]))

    got = vector([0, 1, 0, 1, 0, 0, 0, 0], [1, 0, 0, 1], [1, 1, 0])
    assert [x for x in got if x] == pytest.approx([0.40824829] * 6)
    got = vector([0, 1, 0, 1, 0, 0, 0, 0], [1, 0, 0, 1], [0, 0, 0])
    assert [x for x in got if x] == pytest.approx([0.5] * 4)
    assert vector([0] * 8, [0] * 4, [0] * 3) == [0.0] * 15


def test_vectors(spark):
    unit = value(spark, s.unit(F.array(F.lit(3.0), F.lit(4.0))))
    assert unit == pytest.approx([0.6, 0.8])
    assert value(spark, s.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert value(spark, s.cosine(F.array(F.lit(1.0)), F.array(F.lit(-1.0)))) == 0.0
    assert value(spark, s.cosine(F.lit(None).cast("array<double>"), F.array(F.lit(1.0)))) == 0.0
